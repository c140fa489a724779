"""Fleet outlier analysis: host profiles, TF-IDF, density clusters, medians, majorities, rarity and drift in time."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrier.functions import scalars as S
from harrier.operators import blocks
from harrier.operators.components import connected_components
from harrier.storage import Scratch

PROCESS = ["name", "parent_name", "uid", "path", "is_high_entropy", "is_suspicious_path"]


# -- profiles


def parent_names(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """parent_name by (machine_id, ppid); of rows that share a pid the last wins, unknown parents read [unknown:N]."""
    names = rows.groupBy("machine_id", F.col("pid").alias("ppid")).agg(F.max_by("name", ord_col).alias("_parent"))
    joined = rows.join(names, ["machine_id", "ppid"], "left")
    return joined.withColumn("parent_name", F.coalesce("_parent", F.concat(F.lit("[unknown:"), F.col("ppid"), F.lit("]")))).drop("_parent")


def process_profile(rows: DataFrame, entropy: float = 4.5, kernel_threads: bool = False) -> DataFrame:
    """(machine_id, signature columns, n): rows per host and process signature."""
    df = parent_names(rows)
    df = df if kernel_threads else df.where(~S.kernel_thread(F.col("name")))
    df = df.withColumn("is_high_entropy", S.text_entropy(F.col("args")) > entropy).withColumn("is_suspicious_path", S.suspicious_path(F.col("path")))
    return df.groupBy("machine_id", *PROCESS).agg(F.count("*").alias("n"))


def merged_profiles(*profiles: tuple[str, DataFrame]) -> DataFrame:
    """Counts of several datasets added up; hosts are named dataset/host where there is more than one."""
    named = [p.withColumn("machine_id", F.concat(F.lit(f"{d}/"), "machine_id")) if len(profiles) > 1 else p for d, p in profiles]
    whole = reduce(lambda a, b: a.unionByName(b), named)
    return whole.groupBy(*(c for c in whole.columns if c != "n")).agg(F.sum("n").alias("n"))


def document_frequency(profile: DataFrame, host: str, *sig: str) -> DataFrame:
    return profile.groupBy(*sig).agg(F.count_distinct(host).alias("df"))


def tf_idf(counts: DataFrame, host: str, sig: str, n: str = "n", normalize: bool = True) -> DataFrame:
    """(host, sig, w): n / host total times ln(N / df) + 1, over the host's length if asked. counts: one row per host and signature.

    Sums run in the order of the signatures, so hosts with the same counts have the same weights to the last bit,
    whatever order their rows come in: what compares vectors can take such hosts as one. The counts are read three times, so they are written first.
    """
    counts = Scratch(counts.sparkSession, "tf-idf").save(counts.select(host, sig, n))
    hosts = counts.select(F.count_distinct(host).alias("_hosts"))
    df = counts.groupBy(sig).agg(F.count("*").alias("_df"))
    w = Window.partitionBy(host).orderBy(sig).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = counts.join(df, sig).crossJoin(F.broadcast(hosts))  # one row
    out = out.withColumn("w", F.col(n) / F.sum(n).over(w) * (F.log(F.col("_hosts") / F.col("_df")) + 1))
    if normalize:
        out = out.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(w)))
    return out.select(host, sig, "w")


def mid_frequency(profile: DataFrame, host: str, sig: str, most: int = 8000) -> DataFrame:
    """Rows of signatures on more than one host but not on all, of the rarest ``most`` signatures."""
    n = profile.select(F.count_distinct(host).alias("_hosts"))
    df = profile.groupBy(sig).agg(F.count_distinct(host).alias("_df")).crossJoin(F.broadcast(n))
    kept = df.where("_df > 1 AND _df < _hosts").orderBy("_df", sig).limit(most).select(sig)
    return profile.join(kept, sig, "left_semi")


# -- density clusters


def dbscan(weights: DataFrame, host: str, sig: str, eps: float = 0.35, least: int = 2) -> DataFrame:
    """(host, cluster): DBSCAN of sparse vectors by Euclidean distance; cluster is the smallest core host, null for noise.

    weights: one row per host and signature, with w. Hosts with the same vector
    are one place, compared once and counted as many; those of zero length are
    one place too. Signatures are ordered by rarity. What a host holds before
    the first one that it shares with another host adds to their distance, so
    only the rarest signatures, up to where their squares exceed eps squared,
    are joined, and hosts that meet there are compared on all. Hosts that
    share nothing are taken to be farther apart than eps (unit vectors are, for
    any eps below sqrt(2)). A neighbourhood includes its own host and its rim.

    Dense fleets are covered by balls first, whose hosts are known to be core hosts of one
    cluster: no two of them are joined. Hosts outside are joined with all, hosts of
    different balls only where a centre's distance allows a neighbour.

    Where many hosts meet at one signature, not they are joined but the blocks that they are dealt to,
    and two blocks are compared as matrices: of hosts that all resemble each other a little, that is every
    pair, a product of a few numbers each. Only counts and a forest of the links leave a pair of blocks.
    Signatures are told apart by a 64-bit hash, a host's are held as one array.
    """
    scratch = Scratch(weights.sparkSession, "dbscan")
    v = weights.select(F.col(host).alias("h"), F.when(F.col(sig).isNotNull(), F.xxhash64(sig)).alias("s"), F.col("w").cast("double").alias("w"))
    hosts = v.groupBy("h").agg(F.array_sort(F.collect_list(F.when(F.col("w") != 0, F.struct("s", "w")))).alias("v"))
    hosts = scratch.save(hosts.select("h", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "hosts")
    places = scratch.save(hosts.groupBy("k1", "k2").agg(F.min("h").alias("rep"), F.count("*").alias("copies")), "places")
    q = F.aggregate("v", F.lit(0.0), lambda q, x: q + x["w"] * x["w"])
    vectors = hosts.where(F.size("v") > 0).join(places.select(F.col("rep").alias("h"), "copies"), "h")
    vectors = scratch.save(vectors.select("h", F.filter("v", lambda x: x["s"].isNotNull()).alias("v"), q.alias("q"), "copies"), "vectors")
    v, norm = vectors.select("h", F.inline("v")), vectors.select("h", "q")

    balls = scratch.save(_cover(v, norm, eps, least, places, scratch))
    dense = scratch.save(_joined_balls(v, norm, balls, eps, scratch))

    by_rarity = Window.partitionBy("h").orderBy("df", "s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(by_rarity), F.lit(0.0))
    rare = v.join(v.groupBy("s").agg(F.count("*").alias("df")), "s").withColumn("before", before)
    rare = rare.where(F.col("before") <= eps * eps + 1e-9).select("h", "s").join(dense, "h", "left")
    grid = scratch.save(_grid(vectors, dense), "grid")
    few = (grid.agg(F.sum("hosts")).first()[0] or 0) <= FEW
    rare = rare.join(F.broadcast(grid.withColumnRenamed("part", "_part")), F.col("part").eqNullSafe(F.col("_part")))  # a row a part
    place = F.least(F.col("n") - 1, F.floor(F.col("first") + F.col("share") * F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / (1 << 30)))
    rare = scratch.save(rare.select("h", "s", "part", "others", F.when(F.col("part").isNull(), -1 - place).otherwise(place).alias("block")), "rare")

    meeting = rare.groupBy("s").agg(F.count("*").alias("hosts"))
    crowded = rare if few else rare.join(meeting.where(F.col("hosts") > CROWD), "s", "left_semi")
    met = scratch.save(_met(crowded, "block"), "met")
    dealt = crowded.select("h", "block", F.col("part").isNotNull().alias("sure")).distinct()
    found = scratch.save(_within(met, vectors.join(dealt, "h"), eps * eps + 1e-12, least), "found")
    close, counts = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL").select(F.col("a").alias("rep"), "near")
    if not few:
        thin = _met(rare.join(meeting.where(F.col("hosts") <= CROWD), "s", "left_semi"), "h").where("a <> b")
        at = lambda c: dealt.select(F.col("h").alias(c), F.col("block").alias(f"{c}_"))
        # what blocks compare is counted there; hosts that no crowd holds are in none
        done = met.select(F.col("a").alias("x"), F.col("b").alias("y"))
        thin = thin.join(at("a"), "a", "left").join(at("b"), "b", "left").withColumns({"x": F.when(F.col("b_").isNotNull(), F.least("a_", "b_")), "y": F.when(F.col("a_").isNotNull(), F.greatest("a_", "b_"))}).join(done, ["x", "y"], "left_anti")
        thin = scratch.save(_near_pairs(thin.select("a", "b"), v, norm, eps * eps + 1e-12).select("a", "b"), "thin")
        ends = thin.union(thin.select("b", "a")).join(places.select(F.col("rep").alias("b"), "copies"), "b")
        close, counts = close.union(thin), counts.union(ends.select("a", "copies"))

    # a part is known to be one cluster of core hosts; its smallest host stands for it
    stands = dense.groupBy("part").agg(F.min("h").alias("stand"))
    of_part = dense.join(stands, "part").select("h", "stand")
    both = close.union(close.select("b", "a"))
    near = counts.groupBy("rep").agg(F.sum("near").alias("near"))
    core = places.join(near, "rep", "left").where(F.col("copies") + F.coalesce("near", F.lit(0)) >= least)
    core = scratch.save(core.select(F.col("rep").alias("h")).union(of_part.select("h")).distinct().join(of_part, "h", "left").select("h", F.coalesce("stand", "h").alias("stand")))
    named = lambda df, c: df.join(core.select(F.col("h").alias(c), F.col("stand").alias(f"{c}_")), c)
    parts = connected_components(named(named(close, "a"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")), scratch)
    label = core.join(parts.withColumnRenamed("node", "stand"), "stand", "left").select("h", F.coalesce("component", "stand").alias("c"))
    rim = both.join(label.withColumnsRenamed({"h": "b"}), "b").groupBy(F.col("a").alias("h")).agg(F.min("c").alias("r"))
    found = places.withColumnRenamed("rep", "h").join(label, "h", "left").join(rim, "h", "left")
    out = hosts.join(found.drop("h"), ["k1", "k2"])
    return out.select(F.col("h").alias(host), F.coalesce("c", "r").alias("cluster"))


CENTRES, ROUNDS, TRIED = 64, 4, 256
FEW = 1 << 14  # fleets of so many places are compared in blocks alone
CROWD = 16  # hosts that meet at a signature and are joined; more are compared in blocks
BLOCK, WAYS = 1 << 20, 12  # weights in a block; blocks that hosts are dealt to at least, where they are more than 1,024 each


def _grid(vectors: DataFrame, dense: DataFrame) -> DataFrame:
    """(part, hosts, n, first, share): the place of a part, or of the hosts in no part (null), on a line of n blocks. Small parts share a block. As many rows as parts, which the cover bounds."""
    hosts = vectors.select("h", F.size("v").alias("weights")).join(dense.select("h", "part"), "h", "left")
    sizes = hosts.groupBy("part").agg(F.count("*").alias("hosts"), F.sum("weights").alias("weights"))
    kind = Window.partitionBy(F.col("part").isNull())
    n = F.greatest(F.ceil(F.sum("weights").over(kind) / BLOCK), F.least(F.ceil(F.sum("hosts").over(kind) / 1024), F.lit(WAYS)))
    share = F.col("weights") / F.sum("weights").over(kind) * F.col("n")
    first = F.sum("share").over(kind.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("n", n).withColumn("share", share).withColumn("first", F.coalesce(first, F.lit(0.0))).select("part", "hosts", "n", "first", "share")


def _met(rare: DataFrame, what: str) -> DataFrame:
    """(a, b): hosts or blocks (column ``what``) to compare, a <= b: those out of parts with all that they share a rare signature with, those of two parts where a host is close enough to the other's centre to have a neighbour there."""
    loose, bound = rare.where("part IS NULL").select("s", F.col(what).alias("a")).distinct(), rare.where("part IS NOT NULL")
    met = loose.join(rare.select("s", F.col(what).alias("b"), F.col("part").isNull().alias("loose")).distinct(), "s").where("NOT loose OR a <= b").select("a", "b")
    reach = bound.select(what, "s", "part", F.explode("others").alias("other")).distinct()
    mine = reach.select(F.col(what).alias("a"), "s", F.col("part").alias("p"), F.col("other").alias("o")).where("p < o")
    theirs = reach.select(F.col(what).alias("b"), "s", F.col("other").alias("p"), F.col("part").alias("o"))
    return met.union(mine.join(theirs, ["s", "p", "o"]).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(pairs: DataFrame, vectors: DataFrame, most: float, least: int) -> DataFrame:
    """What blocks find that are compared pair by pair: (a, null, near), the copies within the squared distance of a host, to be added up, and (a, b, null), links.

    Of the links between hosts that a pair of blocks shows to be core hosts, a forest; all others. vectors: h, block, v, q, copies, and sure, whether it is known to be a core host.
    """
    n, h = pairs.count(), dict(vectors.dtypes)["h"]
    sides = [vectors.join(F.broadcast(pairs) if n <= 100_000 else pairs, F.col("block") == F.col(c)).withColumn("right", F.lit(c == "b")) for c in ("a", "b")]
    dealt = sides[0].union(sides[1].where("a <> b")).select("a", "b", "right", "h", "v", "q", "copies", "sure")
    return dealt.repartition(max(1, min(n, 2000)), "a", "b").groupBy("a", "b").applyInArrow(_compare_blocks(most, least), f"a {h}, b {h}, near long")


def _near_pairs(pairs: DataFrame, v: DataFrame, norm: DataFrame, most: float) -> DataFrame:
    """(a, b, d2) of the pairs whose squared distance is at most ``most``; both share a signature."""
    a, b = v.withColumnsRenamed({"h": "a", "w": "wa"}), v.withColumnsRenamed({"h": "b", "w": "wb"})
    dots = pairs.join(a, "a").join(b, ["b", "s"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    qa, qb = norm.withColumnsRenamed({"h": "a", "q": "qa"}), norm.withColumnsRenamed({"h": "b", "q": "qb"})
    return dots.join(qa, "a").join(qb, "b").withColumn("d2", F.col("qa") + F.col("qb") - 2 * F.col("dot")).where(F.col("d2") <= most).select("a", "b", "d2")


def _compare_blocks(most: float, least: int):
    def compare(both: pa.Table) -> pa.Table:
        both = both.sort_by([("right", "ascending"), ("h", "ascending")]).combine_chunks()
        n, size = pc.sum(pc.invert(both["right"])).as_py(), len(both)
        copies, sure, q = (both[c].to_numpy() for c in ("copies", "sure", "q"))
        by_name = pc.sort_indices(both["h"]).to_numpy().astype(np.int64)  # the smallest host leads a tree
        rank, lead = np.argsort(by_name), np.arange(size)
        near, single = np.zeros(size, np.int64), []
        for x, y in blocks.links(both["v"], q, n, most):
            near += blocks.sums(x, copies[y], size) + blocks.sums(y, copies[x], size)
            if least <= 2:  # both ends are core hosts
                blocks.merge(lead, rank[x], rank[y])
        if least > 2:
            core = sure | (copies + near >= least)
            for x, y in blocks.links(both["v"], q, n, most):
                inner = core[x] & core[y]
                blocks.merge(lead, rank[x[inner]], rank[y[inner]])
                single.append((x[~inner], y[~inner]))
        led, told = np.flatnonzero(lead != np.arange(size)), np.flatnonzero(near)
        x, y = (np.concatenate([by_name[z], *(s[k] for s in single)]) for k, z in enumerate((led, lead[led])))
        h, none = both["h"].combine_chunks(), lambda k, kind: pa.nulls(k, kind)
        a = pa.concat_arrays([h.take(pa.array(x)), h.take(pa.array(told))])
        b = pa.concat_arrays([h.take(pa.array(y)), none(len(told), h.type)])
        return pa.table({"a": a, "b": b, "near": pa.concat_arrays([none(len(x), pa.int64()), pa.array(near[told])])})

    return compare


def _to_centres(v: DataFrame, norm: DataFrame, centres: DataFrame, most: float) -> DataFrame:
    """(h, centre, d2) of hosts and centres within the squared distance; centres (column h) are few, so this takes a bounded number of pairs a host."""
    vc = v.join(F.broadcast(centres), "h").withColumnsRenamed({"h": "centre", "w": "wc"})
    dots = v.join(vc, "s").groupBy("h", "centre").agg(F.sum(F.col("w") * F.col("wc")).alias("dot"))
    qc = norm.join(F.broadcast(centres), "h").withColumnsRenamed({"h": "centre", "q": "qc"})
    return dots.join(norm, "h").join(F.broadcast(qc), "centre").withColumn("d2", F.col("q") + F.col("qc") - 2 * F.col("dot")).where(F.col("d2") <= most).select("h", "centre", "d2")


def _cover(v: DataFrame, norm: DataFrame, eps: float, least: int, places: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, centre): hosts in balls of radius eps / 2 that hold ``least`` hosts or more. They are within eps of each other, so all are core and in one cluster.

    Centres are hosts of least hash, CENTRES in each of at most ROUNDS rounds, each among the
    hosts that no ball holds yet; where hosts are dense, some are drawn. Of large fleets, centres are tried
    on a few hosts first. Very short vectors stay out: only of longer ones does a distance within eps imply a common signature.
    """
    free = norm.where(F.col("q") > eps * eps / 2 + 1e-9)
    out = v.select("h", F.col("h").alias("centre")).where("false")
    for _ in range(ROUNDS):
        left = free.count()
        if left <= CENTRES:
            break
        centres = scratch.save(free.orderBy(F.xxhash64("h"), "h").limit(CENTRES).select("h"), "centres")
        if left > 4 * TRIED:
            tried = free.where(F.pmod(F.xxhash64(F.lit("tried"), "h"), F.lit(left // TRIED)) == 0).select("h")
            tried = _to_centres(v.join(tried, "h", "left_semi"), norm, centres, eps * eps / 4 - 1e-9)
            if 8 * tried.select("h").distinct().count() < TRIED:
                break
        held = _to_centres(v.join(free.select("h"), "h", "left_semi"), norm, centres, eps * eps / 4 - 1e-9)
        held = scratch.save(held.join(places.select(F.col("rep").alias("h"), "copies"), "h"), "in-reach")
        reach = held.groupBy("centre").agg((-F.sum("copies")).alias("_reach"))
        held = held.join(F.broadcast(reach), "centre").groupBy("h").agg(F.min(F.struct("_reach", "centre")).alias("m")).select("h", "m.centre")
        sizes = held.join(places.select(F.col("rep").alias("h"), "copies"), "h").groupBy("centre").agg(F.sum("copies").alias("n"))
        held = scratch.save(held.join(F.broadcast(sizes.where(F.col("n") >= least).select("centre")), "centre", "left_semi").select("h", "centre"), "held")
        out = out.union(held)
        free = scratch.save(free.join(held, "h", "left_anti"), "free")
        if 8 * held.count() < left:
            break
    return out


def _joined_balls(v: DataFrame, norm: DataFrame, balls: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """(h, part, others): balls of which one holds a host within eps of the other's centre are one part; others are the parts whose centres are near enough for a neighbour there."""
    if balls.isEmpty():
        return balls.select("h", F.col("centre").alias("part"), F.array("centre").alias("others"))
    centres = scratch.save(balls.select(F.col("centre").alias("h")).distinct(), "all-centres")
    near = scratch.save(_to_centres(v.join(balls.select("h"), "h", "left_semi"), norm, centres, (1.5 * eps + 1e-6) ** 2), "near-centres")
    own = balls.withColumnRenamed("centre", "own")
    links = near.where(F.col("d2") <= eps * eps + 1e-12).join(own, "h").select(F.col("own").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()
    joined = connected_components(links, scratch)
    part = centres.join(joined.withColumnRenamed("node", "h"), "h", "left").select(F.col("h").alias("centre"), F.coalesce("component", "h").alias("part"))
    mine = balls.join(F.broadcast(part), "centre").select("h", "part")
    reach = near.join(F.broadcast(part.withColumnRenamed("part", "other")), "centre").join(mine, "h").where("other <> part").groupBy("h").agg(F.collect_set("other").alias("others"))
    return mine.join(reach, "h", "left").select("h", "part", F.coalesce("others", F.array().cast(dict(mine.dtypes)["part"].join(("array<", ">")))).alias("others"))


def process_outliers(profile: DataFrame, eps: float = 0.35, least: int = 2) -> DataFrame:
    """Hosts that are noise, in a minority cluster, or at risk: severity, distance, reasons and counts."""
    sig = F.to_json(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in PROCESS)))
    p = Scratch(profile.sparkSession, "outliers").save(profile.withColumn("sig", sig))
    clusters = dbscan(tf_idf(p.groupBy("machine_id", "sig").agg(F.sum("n").alias("n")), "machine_id", "sig"), "machine_id", "sig", eps, least)
    largest = clusters.where("cluster IS NOT NULL").groupBy("cluster").count().orderBy(F.col("count").desc(), "cluster").limit(1).select(F.col("cluster").alias("_largest"))
    common = reduce(lambda a, x: a | F.col("name").contains(x), S.COMMON_ROOT, F.lit(False))
    df = document_frequency(p, "machine_id", "sig")
    root = (F.col("uid") == 0) & ~common
    risk = root | F.col("is_suspicious_path") | F.col("is_high_entropy")
    why = F.array_join(F.array_compact(F.array(F.when(root, "root_no_whitelist"), F.when(F.col("is_suspicious_path"), "suspicious_path"), F.when(F.col("is_high_entropy"), "high_entropy_args"))), ",")
    shown = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "(none)").otherwise(F.col(c))
    told = F.concat(F.lit("RISK DETECTED: name="), "name", F.lit(" path="), shown("path"), F.lit(" parent="), shown("parent_name"), F.lit(" uid="), "uid", F.lit(" count="), "n", F.lit(" reasons="), why)
    rare = (F.col("df") == 1) & ~common
    rows = p.join(df, "sig").withColumn("risk", F.coalesce(risk, F.lit(False)))
    hosts = rows.groupBy("machine_id").agg(
        F.sum("n").alias("process_count"),
        F.coalesce(F.sum(F.when(F.col("risk"), F.col("n"))), F.lit(0)).alias("suspicious_process_count"),
        F.max("risk").alias("risk"),
        F.array_sort(F.array_union(F.collect_set(F.when(F.col("risk"), told)), F.collect_set(F.when(rare, F.concat(F.lit("Rare process: "), "name"))))).alias("reasons"),
    )
    out = hosts.join(clusters, "machine_id").crossJoin(F.broadcast(largest)) if largest.count() else hosts.join(clusters, "machine_id").withColumn("_largest", F.lit(None))
    noise, minority = F.col("cluster").isNull(), F.coalesce(F.col("cluster") != F.col("_largest"), F.lit(False))
    severity = F.when(F.col("risk"), F.when(F.col("suspicious_process_count") > 5, "critical").otherwise("high")).when(F.size("reasons") == 0, "low").otherwise("medium")
    mixed = F.array(F.lit("Process mix differs from fleet majority cluster (no behavioral/root/rare-process flags)."))
    out = out.where(noise | minority | F.col("risk")).withColumn("severity", severity).withColumn("distance", F.when(noise, 1.5).otherwise(0.8))
    return out.withColumn("reasons", F.when(F.size("reasons") == 0, mixed).otherwise(F.col("reasons"))).drop("_largest", "risk")


# -- files


def median_outliers(files: DataFrame, host: str, path: str, mtime: str, least_hosts: int = 3, hours: int = 24, signed: bool = False) -> DataFrame:
    """Rows whose time is more than so many whole hours from the path's upper median over at least three hosts. files: one row per host and path. Signed hours are below 0 for older files."""
    rows = files.withColumn("_t", F.unix_seconds(F.col(mtime).cast("timestamp")))
    # counts of equal times first: a path that all hosts have sends a row for each time, not for each host, through its window
    times = rows.where("_t IS NOT NULL").groupBy(F.col(path).alias("_p"), F.col("_t").alias("_median")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_p")
    ranked = times.withColumn("_n", F.sum("_c").over(w)).withColumn("_to", F.sum("_c").over(w.orderBy("_median")))
    middle = F.floor(F.col("_n") / 2)
    medians = ranked.where((F.col("_n") >= least_hosts) & (F.col("_to") > middle) & (F.col("_to") - F.col("_c") <= middle)).select("_p", "_median")
    apart = F.floor(F.abs(F.col("_t") - F.col("_median")) / 3600)
    out = rows.join(medians, F.col(path) == F.col("_p")).withColumn("hours_apart", apart.cast("long"))
    out = out.where(F.col("hours_apart") > hours)
    out = out.withColumn("hours_apart", F.col("hours_apart") * F.signum(F.col("_t") - F.col("_median")).cast("long")) if signed else out
    return out.select(*files.columns, "hours_apart")


def majority_outliers(files: DataFrame, host: str, path: str, value: str, least_hosts: int = 3, least_votes: int = 2) -> DataFrame:
    """Rows whose value differs from the path's most frequent one (ties: the smaller value). files: one row per host and path."""
    votes = files.where(F.col(value).isNotNull()).groupBy(path, value).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(path)
    best = votes.withColumn("hosts", F.sum("votes").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.col("votes").desc(), value)))
    best = best.where((F.col("_k") == 1) & (F.col("hosts") >= least_hosts) & (F.col("votes") >= least_votes))
    best = best.select(F.col(path).alias("_p"), F.col(value).alias("majority"), "votes", "hosts")
    return files.join(best, F.col(path) == F.col("_p")).where(F.col(value) != F.col("majority")).select(host, path, value, "majority", "votes", "hosts")


def minority_flags(rows: DataFrame, host: str, path: str, flag: Column, least_hosts: int = 3) -> DataFrame:
    """Hosts on the smaller side of a flag, of paths that at least three hosts have and where the other side has a strict majority of two at least."""
    per = rows.groupBy(host, path).agg(F.bool_or(flag).alias("flag"))
    w = Window.partitionBy(path)
    counted = per.withColumn("yes", F.count_if("flag").over(w)).withColumn("hosts", F.count("*").over(w)).withColumn("no", F.col("hosts") - F.col("yes"))
    mine = F.when(F.col("flag"), F.col("yes")).otherwise(F.col("no"))
    return counted.where((F.col("hosts") >= least_hosts) & (mine > 0) & (mine < F.col("hosts") - mine) & (F.col("hosts") - mine >= 2)).select(host, path, "flag", "yes", "no")


def without_baseline(rows: DataFrame, host: str, sig: str, fraction: float = 1.0) -> DataFrame:
    """Rows whose signature is on fewer than ceil(fraction N) hosts."""
    n = rows.select(F.count_distinct(host).alias("_hosts"))
    base = rows.groupBy(sig).agg(F.count_distinct(host).alias("_df")).crossJoin(F.broadcast(n)).where(F.col("_df") >= F.ceil(F.col("_hosts") * fraction))
    return rows.join(base.select(sig), sig, "left_anti")


def without_common(rows: DataFrame, dataset: str, checksum: str) -> DataFrame:
    """Rows whose checksum isn't in every dataset or host."""
    n = rows.select(F.count_distinct(dataset).alias("_all"))
    common = rows.groupBy(checksum).agg(F.count_distinct(dataset).alias("_n")).crossJoin(F.broadcast(n)).where("_n = _all").select(checksum)
    return rows.join(common, checksum, "left_anti")


def rare_examples(rare: DataFrame, host: str, order: list[Column], most: int = 20) -> DataFrame:
    """The first rows of each host, with ``rank`` and ``more``, the number of rows beyond them."""
    w = Window.partitionBy(host)
    out = rare.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - most))
    return out.where(F.col("rank") <= most)


def file_flags(files: DataFrame) -> DataFrame:
    """files with the risk columns: suspicious, world, group, recent, root. Needs path, uid, owner, permissions, mtime, timestamp."""
    path, mode, uid = F.col("path"), F.col("permissions"), S.effective_uid(F.col("uid"), F.col("owner"))
    out = files.withColumns({"suspicious": S.suspicious_path(path), "world": S.world_writable(mode), "group": S.group_writable(mode), "root": F.coalesce(uid == 0, F.lit(False))})
    return out.withColumn("recent", S.recently_modified(path, F.col("timestamp"), F.col("mtime"), uid, F.col("suspicious"), F.col("world"), F.col("group")))


def file_outliers(files: DataFrame, most: int = 20, eps: float = 0.35) -> DataFrame:
    """(machine_id, severity, cluster, reasons): times and owners off the fleet's, then risk, of each host's rare files."""
    f = Scratch(files.sparkSession, "files").save(file_flags(files))
    one = f.groupBy("machine_id", "path").agg(*(F.max_by(c, "ord").alias(c) for c in ("mtime", "owner", "permissions", "size")))
    meta = median_outliers(one, "machine_id", "path", "mtime").select("machine_id", F.concat(F.lit("mtime off fleet median: "), "path").alias("reason"))
    for c in ("owner", "permissions"):
        odd = majority_outliers(one.where(S.starts_any(F.col("path"), S.NOTED_PREFIXES)), "machine_id", "path", c)
        meta = meta.union(odd.select("machine_id", F.concat(F.lit(f"{c} off fleet majority: "), "path")))
    flags = [F.col(c) for c in ("suspicious", "world", "group", "recent", "root")]
    risk = f.groupBy("machine_id", "path").agg(*(F.bool_or(c).alias(c) for c in ("suspicious", "world", "group", "recent", "root")), F.count("*").alias("n"))
    rare = risk.join(document_frequency(risk, "machine_id", "path").where("df = 1"), "path", "left_semi").where(S.rare_file_interesting(F.col("path"), *flags))
    rare = rare.withColumn("priority", S.rare_file_priority(F.col("path"), *flags)).withColumn("reason", F.concat(F.lit("Rare file access: "), "path", S.rare_file_qualifier(*flags)))
    shown = rare_examples(rare, "machine_id", [F.col("priority").desc(), F.col("n").desc(), F.col("path")], most)
    mid = mid_frequency(f.groupBy("machine_id", "path").agg(F.count("*").alias("n")), "machine_id", "path")
    clusters = dbscan(tf_idf(mid, "machine_id", "path"), "machine_id", "path", eps)
    hosts = rare.groupBy("machine_id").agg(F.count_if(F.col("suspicious") | F.col("world") | F.col("recent")).alias("risky"), F.max("recent").alias("recent"))
    reasons = shown.select("machine_id", "reason").union(meta).groupBy("machine_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    odd = meta.groupBy("machine_id").agg(F.lit(True).alias("odd"))
    out = reasons.join(hosts, "machine_id", "left").join(odd, "machine_id", "left").join(clusters, "machine_id", "left")
    severity = F.when(F.col("odd"), "critical").when(F.col("recent") & (F.col("risky") > 0), "critical").when(F.col("risky") > 5, "critical").when(F.col("risky") > 0, "high").otherwise("medium")
    return out.select("machine_id", severity.alias("severity"), "cluster", "reasons")


# -- time and fusion


def new_signatures(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of the later snapshot that the earlier one hasn't."""
    return after.select(*keys).distinct().join(before.select(*keys).distinct(), list(keys), "left_anti")


def modified_files(before: DataFrame, after: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """Paths of both snapshots whose time differs or was unknown before."""
    old = before.select(*keys, F.col(mtime).alias("old_mtime"))
    return after.join(old, keys).where(F.col(mtime).isNotNull() & ~F.col(mtime).eqNullSafe(F.col("old_mtime"))).select(*keys, "old_mtime", F.col(mtime).alias("new_mtime"))


def snapshot_series(rows: DataFrame, snapshot: str, *keys: str) -> DataFrame:
    """(snapshot, keys): what each snapshot has that the one before it hadn't; the first one is the start."""
    order = rows.select(snapshot).distinct().withColumn("_before", F.lag(snapshot).over(Window.orderBy(snapshot)))  # one row per snapshot
    now = rows.select(snapshot, *keys).distinct().join(order.where("_before IS NOT NULL"), snapshot)
    was = rows.select(F.col(snapshot).alias("_before"), *keys).distinct()
    return now.join(was, ["_before", *keys], "left_anti").select(snapshot, *keys)


def fuse_detectors(*found: DataFrame) -> DataFrame:
    """One row per host: the largest score, sorted distinct reasons, severity by score. found: host, detector, score, reason."""
    whole = reduce(lambda a, b: a.unionByName(b), found)
    out = whole.groupBy("host").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("detector")).alias("detectors"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out.withColumn("severity", S.severity_of_score(F.col("score")))
