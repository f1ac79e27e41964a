"""Connected groups of linked rows, and links found through shared buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import Scratch


def connected(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, root) for each id in ``links`` (a, b): root is the smallest id of its group.

    Alternates the large-star and small-star steps on an edge table until it stands
    still. Each step is a partial aggregation and a join, so a hub with a third of
    all rows is pre-aggregated and split like any other skewed join key. Nulls and
    self links are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen, turn = None, 0
    while True:
        edges = scratch.table(edges, f"{tag}-{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if turn:
            scratch.drop(f"{tag}-{turn - 1}")
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen, turn = state, turn + 1
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("u > m").select("u", F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        ).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def joined(groups: DataFrame, links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """The groups (id, root) after further links (a, b). Only the groups that these links name
    are searched, each as one node."""
    ends = (groups.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    top = links.join(next(ends), "a", "left").join(next(ends), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    top = scratch.table(connected(top, scratch, f"{tag}-top"), f"{tag}-roots")
    every = groups.union(top.select("id", "id")).distinct()
    return scratch.table(every.join(top.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root")), tag)


Side = Callable[[str], Column]
#: Members of several groups in a bucket; fuller ones are split by further keys before pairs are made.
FULL = 256


def link_through_buckets(
    postings: DataFrame,
    items: list[str],
    near: Callable[[Side, Side], Column],
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    marks: Callable[[], DataFrame],
    alike: Callable[[Side, Side], Column],
    resplit: Callable[[DataFrame], DataFrame] | None = None,
    given: DataFrame | None = None,
    spent: str = "",
    prepare: Callable[[DataFrame], None] | None = None,
    order: list[str] | None = None,
    parts: int = 1,
    far: Callable[[Side, Side], Column] | None = None,
) -> DataFrame:
    """(id, root) of the groups that the links between members of a bucket make.

    ``postings``: (key, id, *items), an id in many buckets. ``near`` is a cheap necessary
    condition on two rows' items, ``alike`` one on the columns that ``marks`` gives (id, ...); ``verify``
    keeps the true links of a table (a, b). ``resplit`` deals the rows of full buckets (key, id, root,
    members, *items and the marks) to smaller ones and may part no linked pair; without it an id is in few
    buckets. ``given``: links (a, b) that need no bucket. ``prepare`` is told the ids (id,
    repeated) that may be verified once the postings are stored; then ``spent``, a table of
    ``scratch``, goes. Postings are shuffled in ``parts`` by key, one after another, as each part
    takes its share of the disk.

    Each bucket's pivot is its least row by ``order`` (items and id, if none is given); a bucket of two that are not near
    has no pair and goes. First an id is held against one pivot, that of most of its
    buckets, which joins large groups of like members in one linear pass. Then, in turns, a member
    of each bucket drawn by hash is held against those of other groups there, by two pairs for two
    groups: large groups that no pivot joined become one. Turns end when the pairs of groups left are
    no more than the rows, or a turn leaves seven in ten of them. Then all pairs whose groups
    still differ meet, with ``near`` and ``alike`` inside the join, so every link that could join two
    groups is tried. With ``resplit`` full buckets are split before. Without it a pair
    is made in the first bucket that both are in, and a bucket's largest group is held
    against the other rows only; the closest pair of two groups by ``far`` is tried first, and
    after it all pairs whose groups still differ.
    """
    own: Side = F.col
    at = lambda row: lambda c: F.col(f"{row}.{c}")
    row = F.struct(*(order or [*items, "id"]))

    def shared_part(part: int) -> DataFrame:
        dealt = postings.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else postings
        dealt = dealt.repartition("key")  # shuffled once, for the count and the join
        pivots = dealt.groupBy("key").agg(F.count("*").alias("members"), F.min(row).alias("pivot"), F.max(row).alias("last"))
        pivots = pivots.where("members > 1").where((F.col("members") > 2) | near(at("pivot"), at("last")))
        out = scratch.table(dealt.join(pivots.select("key", "pivot"), "key"), f"postings/part={part}")
        scratch.tidy()
        return out

    shared = shared_part(0)
    for part in range(1, parts):
        shared = shared.unionByName(shared_part(part))
    if prepare:
        prepare(shared.select("id"))
    if spent:
        scratch.drop(spent)
    scratch.tidy()
    fits = (F.col("pivot.id") != F.col("id")) & near(at("pivot"), own)
    votes = shared.where(fits).groupBy("id", F.col("pivot.id").alias("a")).agg(F.count("*").alias("n"))
    first = votes.groupBy(F.col("id").alias("b")).agg(F.max(F.struct("n", "a")).alias("most")).select("most.a", "b")
    links = verify(first)
    links = scratch.table(links if given is None else links.unionByName(given), "links-pivot")
    groups = scratch.table(connected(links, scratch, "groups-pivot"), "groups")

    def split(rows: DataFrame, tag: str, spent: str, more: DataFrame | None = None) -> DataFrame:
        """(key, id, *items, root, members) with the columns of ``more``: the buckets of several groups."""
        placed = rows.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
        placed = scratch.table(placed if more is None else placed.join(more, "id"), f"{tag}-all")
        scratch.drop(spent)
        several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
        placed = scratch.table(placed.join(several, "key"), tag)
        scratch.drop(f"{tag}-all")
        scratch.tidy()
        return placed

    def spread(rows: DataFrame) -> int:
        """Pairs of groups that meet in the buckets."""
        held = rows.select("key", "root").distinct().groupBy("key").agg(F.count("*").alias("g"))
        return held.agg(F.sum(F.expr("g * (g - 1) div 2"))).first()[0] or 0

    def checked(pairs: DataFrame, tag: str) -> DataFrame:
        """The links of stored pairs, tried in rounds of about ``most`` pairs: what a round shuffles goes with it."""
        rounds, links = 1 + pairs.count() // most, None
        for k in range(rounds):
            scratch.tidy()
            part = scratch.table(verify(pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)), f"{tag}-{k}")
            links = part if links is None else links.unionByName(part)
        scratch.tidy()
        return links

    rows = split(shared.select("key", "id", *items), "split-0", "postings", marks())
    most = max(1, 2 * rows.count())
    left, turn = spread(rows), 0
    while left > 2 * rows.count():
        lead = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "root", "id", *[c for c in rows.columns if c not in ("key", "id", "root", "members")])).alias("lead"))
        fits = (F.col("lead.root") != F.col("root")) & near(at("lead"), own) & alike(at("lead"), own)
        two = rows.join(lead, "key").where(fits).groupBy("lead.root", "root").agg(*(f(F.struct(F.col("lead.id").alias("a"), F.col("id").alias("b"))).alias(f.__name__) for f in (F.min, F.max)))
        two = two.select(F.explode(F.array("min", "max")).alias("pair")).select("pair.*").distinct()
        groups = joined(groups, scratch.table(verify(two), f"links-lead-{turn}"), scratch, f"groups-lead-{turn}")
        rows, turn = split(rows.drop("root", "members"), f"split-{turn + 1}", f"split-{turn}"), turn + 1
        before, left = left, spread(rows)
        if 10 * left > 7 * before:
            break
    pair = (F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    sides = lambda *of: (df.select(F.col("key").alias(f"{x}_key"), F.struct("*").alias(x)) for x, df in zip("xy", of, strict=True))
    meet, like = F.col("x_key") == F.col("y_key"), near(at("x"), at("y")) & alike(at("x"), at("y"))
    if resplit:
        full = resplit(rows.where(F.col("members") > FULL))
        rows = rows.where(F.col("members") <= FULL).drop("members").unionByName(full.drop("members"))
        one, two = sides(rows, rows)
        pairs = one.join(two, meet & (F.col("x.root") < F.col("y.root")) & like).select(*pair).distinct()
    else:
        sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
        tops = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("t")).select("key", F.col("t.root").alias("top"))
        held = rows.groupBy(*[c for c in rows.columns if c not in ("key", "members")]).agg(F.collect_set("key").alias("keys"))
        held = held.withColumn("key", F.explode("keys")).withColumn("keys", F.expr("filter(keys, k -> k < key)"))
        rows = scratch.table(held.join(tops, "key"), "meeting")
        scratch.drop(f"split-{turn}")
        scratch.tidy()
        one, two = sides(rows.where("root <> top"), rows)
        other = (F.col("y.root") == F.col("y.top")) | (F.col("x.root") < F.col("y.root"))
        apart = F.col("x.root") != F.col("y.root")
        roots = (f("x.root", "y.root").alias(c) for f, c in ((F.least, "low"), (F.greatest, "high")))
        pairs = one.join(two, meet & apart & other & like & ~F.arrays_overlap("x.keys", "y.keys")).select(*roots, far(at("x"), at("y")).alias("far"), *pair)
        pairs = scratch.table(pairs, "pairs")
        scratch.drop("meeting")
        best = pairs.groupBy("low", "high").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
        best = scratch.table(best, "best")
        groups = joined(groups, checked(best, "links-closest"), scratch, "groups-closest")
        ends = (groups.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
        pairs = pairs.join(best, ["a", "b"], "left_anti").select("a", "b").join(next(ends), "a", "left").join(next(ends), "b", "left")
        pairs = scratch.table(pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "pairs-rest")
        scratch.drop("pairs")
        scratch.drop("best")
    rest = scratch.table(verify(pairs), "links-rest") if resplit else checked(pairs, "links-rest")
    scratch.drop(f"split-{turn}" if resplit else "pairs-rest")
    return joined(groups, rest, scratch, "groups-final")
