"""URL filters: rules first, then a path-template tree learned per host.

A url's host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end,
with A-Z lower-cased; its path runs from there to ``?``, ``#`` or the end. Null urls and urls
without ``://`` have an empty host and path. The longest rule that fits decides; of equally long ones
the last in the order of their texts.

The tree has a root per host and a level per path segment, however many. Segments with a digit are
variable and become ``*`` at once, keeping their file extension. Below a node with more than
``max_children`` different children, those with under ``min_share`` of its pages become ``*`` as well.

Labels come from the rules: a page that a rule fits counts as blocked or allowed. Sibling branches that
are statistically alike become one: labelled branches on one side of ``reject_at`` whose blocked share
doesn't differ from the others' of that side (two-proportion z-test) are merged, and a branch without
labels joins the side whose next segments are distributed as its own (chi-square test), the allowed one
if both are. A template's purity is its blocked share smoothed towards its parent's,
``(blocked + strength * parent) / (labelled + strength)``, down from the root, which is smoothed towards
``prior``, so a template without labels has its nearest labelled ancestor's leaning. Templates are
rejected from ``reject_at`` on. ``prior`` is 0: hosts without any label are allowed.

All levels are worked out at once: each distinct (host, shape) row gives one row per segment, keyed by
a hash of the segments before it, and counts are grouped by these keys, so the number of shuffles
doesn't grow with the depth, and no host's pages or children ever meet in one task. Branches merge as
they stand in the raw tree.

Very long urls have as many rows as segments. Repeated rows count as often as they occur and give repeated
rows; columns other than page_id and url are ignored, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise

#: (verdict, host, path): fixed values of the operator's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins of a branch's next segments, and upper 5 % points of chi-square by degrees of freedom 1 to 15: fixed values.
BINS = 16
CHI_SQUARE = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996)


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def shape_of(path: Column) -> Column:
    """The path's segments, those with a digit as ``*`` and their extension."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def chained(leaves: DataFrame, columns: str) -> DataFrame:
    """A row per segment of each leaf (leaf, segments, ...): its place, the hash of the segments before it
    (``node``) and with it (``child``), and the bin of the next one. ``columns`` go along."""
    keep = [c.strip() for c in columns.split(",")]
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, segment, node, child, bins = [], [], [], [], [], []
            for i, segments in enumerate(batch.column(len(keep)).to_pylist()):
                before = 0
                for j, s in enumerate(segments):
                    after = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), before & 0xFFFFFFFFFFFFFFFF)
                    following = segments[j + 1] if j + 1 < len(segments) else ""
                    rows.append(i)
                    place.append(j)
                    segment.append(s)
                    node.append(before)
                    before = after - (1 << 64) if after >= 1 << 63 else after
                    child.append(before)
                    bins.append(xxhash.xxh64_intdigest(following.encode("utf-8", "surrogatepass"), 5) % BINS)
                if len(rows) >= 50_000 or i + 1 == batch.num_rows:
                    own = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(own) for k in range(len(keep))), pa.array(place, pa.int32()), pa.array(segment, pa.string()), pa.array(node, pa.int64()), pa.array(child, pa.int64()), pa.array(bins, pa.int32())],
                        names=[*keep, "place", "segment", "node", "child", "bin"],
                    )
                    rows, place, segment, node, child, bins = [], [], [], [], [], []

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", place int, segment string, node long, child long, bin int"
    return leaves.select(*keep, "segments").mapInArrow(run, schema)


def _fold(values: Column, other: Column, f) -> Column:
    """Sum of f(x, y) over two arrays side by side."""
    return F.aggregate(F.zip_with(values, other, f), F.lit(0.0), lambda a, x: a + x)


def _like(own: Column, side: Column) -> Column:
    """Is the chi-square of two rows of counts within its 5 % point?"""
    n, m = (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) for x in (own, side))
    k = F.sqrt(F.try_divide(m, n))
    chi = _fold(own, side, lambda x, y: F.coalesce(F.try_divide((x * k - F.try_divide(y, k)) * (x * k - F.try_divide(y, k)), x + y), F.lit(0.0)))
    freedom = F.greatest(_fold(own, side, lambda x, y: F.when(x + y > 0, 1.0).otherwise(0.0)) - 1, F.lit(1.0)).cast("int")
    limit = F.element_at(F.array(*[F.lit(v) for v in CHI_SQUARE]), F.least(freedom, F.lit(len(CHI_SQUARE))))
    return (n > 0) & (m > 0) & (chi <= limit)


def merged_names(steps: DataFrame, max_children: int, min_share: float, z: float, reject_at: float) -> DataFrame:
    """host, node, child, name of each branch of the tree: ``*`` if rare, ``+allow`` or ``+block`` if it is
    merged with others, else its own segment."""
    by_bin = steps.groupBy("host", "node", "child", "bin").agg(F.min("segment").alias("segment"), *(F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")))
    bins = lambda own: [F.sum(F.when(F.col("bin") == b, F.col(own)).otherwise(0)).cast("double") for b in range(BINS)]
    children = by_bin.groupBy("host", "node", "child").agg(
        F.min("segment").alias("segment"), *(F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")), F.array(*bins("pages")).alias("next"),
    )
    blocks = F.when(F.col("labelled") > 0, F.col("blocked") >= reject_at * F.col("labelled"))
    children = materialise(children.withColumn("blocks", blocks), "branches")
    side = lambda c, which: F.sum(F.when(F.col("blocks") == F.lit(which), F.col(c)).otherwise(0))
    nodes = children.groupBy("host", "node").agg(
        F.count("*").alias("n"), F.sum("pages").alias("all_pages"),
        *(side(c, w).alias(f"{c}_{w}".lower()) for c in ("labelled", "blocked") for w in (True, False)),
        *(F.array(*[F.sum(F.when(F.col("blocks") == F.lit(w), F.get("next", F.lit(b))).otherwise(0.0)) for b in range(BINS)]).alias(f"next_{w}".lower()) for w in (True, False)),
    )
    out = children.join(nodes, ["host", "node"])
    at = lambda c: F.when(F.col("blocks"), F.col(f"{c}_true")).otherwise(F.col(f"{c}_false"))
    other_n, other_b = at("labelled") - F.col("labelled"), at("blocked") - F.col("blocked")
    rate = at("blocked") / F.greatest(at("labelled"), F.lit(1))
    error = F.sqrt(rate * (1 - rate) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(other_n, F.lit(1))))
    apart = F.abs(F.col("blocked") / F.greatest("labelled", F.lit(1)) - other_b / F.greatest(other_n, F.lit(1)))
    alike = (other_n > 0) & (apart <= F.lit(z) * error + 1e-12)
    near_block, near_allow = (_like(F.col("next"), F.col(f"next_{w}")) for w in ("true", "false"))
    joins = F.when(near_allow, "+allow").when(near_block, "+block")
    rare = (F.col("n") > max_children) & (F.col("pages") < F.lit(min_share) * F.col("all_pages"))
    # A labelled branch keeps its own name unless there is another to merge with; those that others join do merge.
    merged = F.when(F.col("blocks").isNull(), joins).when(alike | (other_n == 0), F.when(F.col("blocks"), "+block").otherwise("+allow"))
    own = F.when(F.col("segment").startswith("+"), F.concat(F.lit("\\"), "segment")).otherwise(F.col("segment"))
    name = F.when(rare, "*").otherwise(F.coalesce(merged, own))
    return out.select("host", "node", "child", name.alias("name"))


def template_verdicts(
    paths: DataFrame, max_children: int = 50, min_share: float = 0.05, z: float = 1.96, strength: float = 4.0, prior: float = 0.0, reject_at: float = 0.5,
) -> DataFrame:
    """``paths`` (host, path, pages, labelled, blocked), distinct: adds template, purity and verdict."""
    shapes = paths.withColumn("segments", shape_of(F.col("path"))).withColumn("shape", F.array_join("segments", "/"))
    # The tree's leaves: far fewer than paths where segments vary.
    counts = ("pages", "labelled", "blocked")
    leaves = shapes.groupBy("host", "shape").agg(F.first("segments").alias("segments"), *(F.sum(c).alias(c) for c in counts))
    leaves = materialise(leaves.withColumn("leaf", F.xxhash64("host", "shape")), "leaves")
    steps = materialise(chained(leaves, "leaf,host,pages,labelled,blocked"), "steps")
    names = merged_names(steps, max_children, min_share, z, reject_at)
    named = steps.select("leaf", "host", "node", "child", "place").join(names, ["host", "node", "child"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    templates = leaves.select("leaf", "host", "shape", "labelled", "blocked").join(named.groupBy("leaf", "host").agg(order.alias("segments")), ["leaf", "host"], "left")
    templates = materialise(templates.withColumn("segments", F.coalesce("segments", F.array().cast("array<string>"))), "templates")
    # Each template's smoothed share, from the root down.
    below = materialise(chained(templates, "leaf,host,labelled,blocked"), "below")
    stats = below.groupBy("host", "child").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
    along = below.select("leaf", "host", "child", "place").join(stats, ["host", "child"])
    line = along.groupBy("leaf", "host").agg(F.array_sort(F.collect_list(F.struct("place", "n", "b"))).alias("line"))
    root = leaves.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("blocked").alias("host_b"))
    smoothed = lambda p, n, b: (b + p * strength) / (n + strength)
    judged = templates.join(root, "host").join(line, ["leaf", "host"], "left")
    purity = F.aggregate(F.coalesce("line", F.array().cast("array<struct<place:int,n:long,b:long>>")), smoothed(F.lit(prior), F.col("host_n"), F.col("host_b")), lambda p, x: smoothed(p, x["n"], x["b"]))
    judged = judged.select("host", "shape", F.concat(F.lit("/"), F.array_join("segments", "/")).alias("template"), purity.alias("purity"))
    return shapes.select("host", "path", "shape").join(judged, ["host", "shape"]).select("host", "path", "template", "purity", F.when(F.col("purity") >= reject_at, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules=RULES, **tree) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", text).withColumn("said", verdict)
    distinct = urls.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked")
    )
    learned = materialise(template_verdicts(distinct, **tree), "verdicts")
    return urls.join(learned, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", "verdict").alias("verdict"), "template", "purity"
    )
